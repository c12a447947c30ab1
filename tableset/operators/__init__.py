"""DataFrame steps. All are lazy unless their text says that a table is written or measured."""
