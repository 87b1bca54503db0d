"""dapple: document and entity analytics as Spark DataFrame operators."""
