from siltworks.llm.handwritten import found_query, kinds_query

QUERIES = {"p1_found": found_query, "p1_kinds": kinds_query}
