"""DataFrame operators: retrieval, ranking, chat, tables, metrics and registry upkeep."""
