"""Query catalogues: named queries over the test tables, with SQL to compare against."""
