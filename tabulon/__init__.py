"""Part of tabulon: relations from spreadsheets, documents and tables, on Spark."""
