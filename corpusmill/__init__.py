"""corpusmill — instruction-corpus preparation and run-log analytics on Spark.

Every operator takes and returns a ``DataFrame`` (or a ``Column``) and never
runs an action while the plan is being built, unless its job is to write.
"""

from corpusmill.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
