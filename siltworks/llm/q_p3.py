from siltworks.llm.leakage import found_query, items_query

QUERIES = {"p3_found": found_query, "p3_items": items_query}
