"""phonolake: text-to-phoneme and corpus analytics expressed as Spark DataFrame plans."""
