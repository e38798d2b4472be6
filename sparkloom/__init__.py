"""sparkloom: a PySpark-native analytics engine for research-literature and document corpora."""
