"""skyledger: telemetry enrichment, sliding-window summaries and shopping-cart
state, written as Spark DataFrame and Structured Streaming operators.

Every operator is a function ``DataFrame -> DataFrame`` (compose with
``df.transform``); nothing calls ``collect`` on data.
"""

__version__ = "0.1.0"
