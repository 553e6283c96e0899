"""Multi-view scene tables as Spark jobs, and training-data operators in ``llm``."""
