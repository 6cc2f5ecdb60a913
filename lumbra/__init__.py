"""Topic reconciliation and ranking as Spark DataFrame operators."""
