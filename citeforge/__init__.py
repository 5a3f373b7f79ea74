"""citeforge: a Spark-first engine for bibliographic reference resolution.

Every operator is declared with the DataFrame API, so Catalyst plans it; Python runs only
where no built-in expression has the semantics, and then over Arrow batches.
"""

__version__ = "0.1.0"
