"""An analytics engine on Spark: named queries over reusable DataFrame operators."""
