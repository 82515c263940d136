"""Training-data operators: ten operators over a `documents` table and the queries that apply them."""
