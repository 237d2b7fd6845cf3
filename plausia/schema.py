"""Types of the store's tables."""

DIST_DDL = "array<struct<value:string,p:double>>"
DELTAS = f"id string, dimension_id string, entity string, attribute string, prior {DIST_DDL}, posterior {DIST_DDL}, surprise double, evidence string, source string, source_reliability double, ts double, valid_time double, cascaded_from string, seq bigint"
DIMENSIONS = f"id string, entity string, attribute string, distribution {DIST_DDL}, last_accessed double"
EVIDENCE_EVENTS = "id string, text string, source string, ts double, speaker string, entities array<string>, terms array<string>"
RELATIONSHIP_EDGES = "source_entity string, relation string, target_entity string, confidence double, evidence string, ts double"
CLAIMS = "entity string, attribute string, value string, reliability double, seq bigint"
EMBEDDINGS = "text_hash string, embedding array<float>"
TABLES = {"deltas": DELTAS, "dimensions": DIMENSIONS, "evidence_events": EVIDENCE_EVENTS, "relationship_edges": RELATIONSHIP_EDGES}
