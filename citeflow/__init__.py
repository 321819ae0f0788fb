"""Part of citeflow, a citation-network analytics engine on PySpark."""
