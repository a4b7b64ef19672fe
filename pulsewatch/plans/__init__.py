"""The registered queries, with the SQL each must agree with."""
