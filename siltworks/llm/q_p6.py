from siltworks.llm.natural import found_query, shares_query

QUERIES = {"p6_found": found_query, "p6_shares": shares_query}
