"""baleprice: Spark-native pricing analytics for recyclable-material listings.

Every operator is a DataFrame -> DataFrame function built from built-in column expressions and Spark ML;
see ``baleprice.plans.catalog`` for the registered queries.
"""

__version__ = "0.1.0"
