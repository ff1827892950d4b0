from corpusmill.functions import text  # noqa: F401
