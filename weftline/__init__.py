"""weftline: web, text, click and graph analytics as composable PySpark DataFrame operators."""
