from siltworks.llm.credentials import found_query, redacted_query

QUERIES = {"p5_found": found_query, "p5_redacted": redacted_query}
