"""Document and knowledge-graph analytics as DataFrame and SQL plans."""
