from siltworks.llm.pairs import found_query, rates_query

QUERIES = {"p2_found": found_query, "p2_rates": rates_query}
