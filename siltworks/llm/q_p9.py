from siltworks.llm.packing import containers_query, documents_query, instructions_query, quality_query

QUERIES = {"p9_assignment": documents_query, "p9_containers": containers_query, "p9_instructions": instructions_query, "p9_quality": quality_query}
