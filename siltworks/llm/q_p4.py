from siltworks.llm.conversations import found_query, recovered_query

QUERIES = {"p4_found": found_query, "p4_recovered": recovered_query}
