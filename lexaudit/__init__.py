"""lexaudit: citation verification over document collections, as Spark plans."""
