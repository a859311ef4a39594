from conftest_llm import documents, table  # noqa: F401
