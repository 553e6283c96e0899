import hashlib
import random
import time

from sceneloom.llm import secrets as sc

from .helpers import documents

KEY = "A-Za-z0-9+/_.=-"


def is_key(c):
    return c.isascii() and (c.isalnum() or c in "+/_.=-")


def plain_spans(text):
    """The fixed patterns by hand, character by character."""
    out, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, i):
                continue
            j = i + len(word)
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            # The separator is one of : and =; any more belong to the value.
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            k = j
            while k < len(text) and is_key(text[k]):
                k += 1
            if k > j:
                if k - j >= 6:
                    out.append((i, 0, k))
                i = k - 1
                break
        i += 1
    i = 0
    while i < len(text):
        if text.startswith("AKIA", i):
            k = i + 4
            while k < len(text) and text[k].isascii() and (text[k].isupper() or text[k].isdigit()):
                k += 1
            if k > i + 4:
                if k - i >= 20:
                    out.append((i, 1, k))
                i = k
                continue
        i += 1
    i = 0
    while i < len(text):
        k = i
        while k < len(text) and text[k] in "0123456789abcdef":
            k += 1
        if k - i >= 24:
            out.append((i, 2, k))
        i = max(k, i + 1)
    return sorted(out)


def test_base_equals_plain(spark):
    rng = random.Random(11)
    bits = ["password", "PASSWD", "Secret", "to\u212aen", "token", "api_key", "apikey", "'", '"', " ", ":", "=", "abc123", "xyz.-_", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "ſecret", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 50_000 + " token: abcdef"]
    rows = sorted(sc.scan(documents(spark, texts)).collect())
    kinds = ["assign", "access", "hex"]
    for row, text in zip(rows, texts, strict=True):
        want = plain_spans(text or "")
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)], text
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in row.spans.split(",") if x and not x.startswith("novel")] == [x for x in joined.split(",") if x]


def test_novel_keys_and_plain_names(spark):
    rng = random.Random(4)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    known = "serviceAccountDisplayName1"
    usual = [f"the credential of {known} is kept apart, {known} only" for _ in range(30)]
    texts = [f"use the private key {key} for this host", *usual, f"nothing here {key}"]
    rows = sorted(sc.scan(documents(spark, texts)).collect())
    start = texts[0].index(key)
    assert rows[0].spans == f"novel:{start}:{start + 40}" and rows[0].n_novel == 1
    assert all(r.n_novel == 0 for r in rows[1:])


def test_copied_keys_are_found(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    make = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    same, twice, many = make(28), make(40), make(30, "0123456789ABCDEF")
    texts = [f"the credential {same} of all"] * 10 + [f"the bearer {twice} and then the credential {twice} again"] + [f"host {i} has the private key {many} too" for i in range(10)]
    rows = sorted(sc.scan(documents(spark, texts)).collect())
    for row, text in zip(rows, texts, strict=True):
        key = next(k for k in (same, twice, many) if k in text)
        assert row.n_novel == text.count(key), text
        assert f"novel:{text.index(key)}:{text.index(key) + len(key)}" in row.spans.split(",")


ALPHABETS = {
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "HEX": "0123456789ABCDEF",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
SENTENCES = ["the private key {} opens host {}", "sent as bearer {} to gate {}", "a credential {} for user {}", "access key {} of region {}", "authorization header {} number {}"]


def planted(seed, each=3):
    """(copies, alphabet, key) of random keys of 20 to 48 characters, and texts that hold each in 1 to 5 different sentences."""
    rng, keys, texts = random.Random(seed), [], []
    for copies in range(1, 6):
        for name, letters in ALPHABETS.items():
            for length in (20, 28, 40, 48):
                for _ in range(each):
                    key = "".join(rng.choice(letters) for _ in range(length))
                    keys.append((copies, name, key))
                    texts += [(rng.choice(SENTENCES).format(key, rng.randrange(1000)), key) for _ in range(copies)]
    return keys, texts


PLAIN = ["getUserAccessTokenFromHeader", "authenticationServiceConfiguration", "privateKeyPasswordCallback", "DEFAULT_CREDENTIAL_PROVIDER_CHAIN", "spring.security.oauth2.client", "com.example.credentials.ProviderFactory", "token_bucket_rate_limiter_v2"]


def plain_novel(text, dictionary):
    """Candidates by hand: key characters soon after a sensitive word, each priced alone."""
    taken, found = [(s, e) for s, _, e in plain_spans(text)], {}
    price = sc.Novelty(dictionary)
    blank = sc.blanked(text)
    for end in [m.end() for m in sc.SENSITIVE.finditer(text)]:
        i = end
        while i < len(text) and i <= end + sc.REACH:
            k = i
            while k < len(text) and is_key(text[k]):
                k += 1
            if k - i >= sc.LEAST_NOVEL:
                s = next(j for j in range(i, k + 1) if j == k or text[j] not in "=.-/+_")
                value = text[s:k]
                if sc.fits(value) and not (s == i == end) and not any(s < b and a < k for a, b in taken):
                    around = blank.replace(value, " " * len(value)) if sc.like_key(value) else blank
                    found[s] = (k, price(around[max(0, s - sc.AROUND) : s], value, around[k : k + sc.AROUND]))
            i = max(k, i + 1)
    return [(s, e) for s, (e, p) in sorted(found.items()) if p >= sc.NOVELTY]


def test_planted_keys_are_found_at_each_number_of_copies(spark):
    keys, texts = planted(31)
    names = [(s.format(n, k), None) for n in PLAIN for s in SENTENCES for k in range(4)]
    docs = documents(spark, [t for t, _ in texts + names])
    dictionary = sc.identifier_dictionary(docs)
    rows = sorted(sc.scan(docs, dictionary).collect())
    hits = {}
    for row, (text, key) in zip(rows, texts + names, strict=True):
        spans = [tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("novel")]
        assert spans == plain_novel(text, dictionary)
        hits.setdefault(key, []).append(bool(spans) if key is None else (text.index(key), text.index(key) + len(key)) in spans)
    for copies in range(1, 6):
        mine = [all(hits[k]) for c, _, k in keys if c == copies]
        assert sum(mine) >= 0.95 * len(mine), copies
    for name in ALPHABETS:
        mine = [all(hits[k]) for _, n, k in keys if n == name]
        assert sum(mine) >= 0.9 * len(mine), name
    # One name of seven costs just the limit in one of the sentences.
    assert sum(hits[None]) <= 0.03 * len(hits[None])


def test_no_rows_and_null_ids(spark):
    assert sc.scan(documents(spark, [])).collect() == []
    rows = sc.scan(documents(spark, ["token=abcdef"] * 2).selectExpr("cast(null as long) as doc_id", "text", "1 as spans")).collect()
    assert [(r.doc_id, r.spans) for r in rows] == [(None, "assign:0:12")] * 2


def test_long_texts_take_time_in_proportion():
    """Many spans and candidates in one text; what is found in a part is found in the whole."""
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    lines = [f"password = {key(20)}\nthe token here is ({key(30)}) and more\n" for _ in range(8000)]
    novelty, spent = sc.Novelty(b""), []
    for n in (1000, 8000):
        text = "".join(lines[:n])
        began = time.perf_counter()
        base = sc.base_spans(text)
        found = sc.novel_spans(text, base, novelty)
        spent.append(time.perf_counter() - began)
        assert len(base) >= n and len(found) == n
    assert spent[1] < 24 * spent[0] + 1
    stuffed = "token=" * 50_000 + " secret-" * 50_000
    began = time.perf_counter()
    sc.novel_spans(stuffed, sc.base_spans(stuffed), novelty)
    assert time.perf_counter() - began < 30


def test_runs_ahead_do_not_hide_those_before():
    """A later sensitive word asks for a run that stands before one which is known already."""
    a, b = "Zk8Qw3Rt6Yp1Lm5Xc", "Hj4Nb7Vd2Gs9Kf3Pq"
    text = f"secret and a token: ({a}) then ({b})"
    found = sc.novel_spans(text, [], sc.Novelty(b""))
    assert [text[s:e] for s, _, e in found] == [a, b]
