from siltworks.llm.quality import found_query, statistics_query

QUERIES = {"p10_found": found_query, "p10_statistics": statistics_query}
