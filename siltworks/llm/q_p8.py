from siltworks.llm.tokens import ids_query, roundtrip_query

QUERIES = {"p8_ids": ids_query, "p8_roundtrip": roundtrip_query}
