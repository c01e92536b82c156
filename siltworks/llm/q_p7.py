from siltworks.llm.parsing import found_query, rates_query

QUERIES = {"p7_found": found_query, "p7_rates": rates_query}
