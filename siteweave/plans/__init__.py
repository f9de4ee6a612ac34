"""The registered queries: operators applied to the driver tables, with their SQL."""
