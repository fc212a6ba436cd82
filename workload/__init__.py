"""Every operator as a query over the given tables, with an ANSI-SQL oracle."""
