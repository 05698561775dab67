"""threadloom: discussion and media-reuse analytics as Spark DataFrame operators."""
