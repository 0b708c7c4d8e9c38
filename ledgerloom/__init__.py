"""Analytics over filings: facts, retrieval, text rules and corpus building as lazy DataFrame plans."""
