"""Training-data operators: packing, tokenising, archives, quality, search, privacy, toxicity, secrets, deduplication.

Nothing outside this folder imports it; ``marlstone.llm.entry`` lists its queries and SQL.
"""
