"""Reading tables: text files, exported sheets, catalog tables."""
