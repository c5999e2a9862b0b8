from tests.llm.helpers import odd  # noqa: F401
