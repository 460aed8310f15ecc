"""tessera: image and annotation analytics as Spark DataFrame operators."""
