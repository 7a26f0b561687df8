"""paperloom: research-corpus analytics expressed as Spark DataFrame plans."""
