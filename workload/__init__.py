"""The registered queries: library plans over the test tables, each next to its SQL statement."""
