"""DataFrame operators, one module per question the library answers."""
