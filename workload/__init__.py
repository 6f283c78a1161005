"""The operators run on the driver's tables, with the SQL to compare them to."""
