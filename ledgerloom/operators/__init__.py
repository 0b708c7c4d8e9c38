"""DataFrame operators over facts, filings, audit rows, pages, chunks and vectors."""
