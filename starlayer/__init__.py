"""starlayer: dimensional-warehouse operators expressed as Spark DataFrame plans.

Every operator is a plain function ``(DataFrame..., parameters) -> DataFrame``.
Nothing is collected inside an operator; the driver only plans.
"""

__version__ = "0.1.0"
