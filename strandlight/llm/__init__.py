"""Training-data operators. Nothing outside this subpackage imports it but ``__spark_entry__``."""
