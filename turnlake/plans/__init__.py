"""Plans that put operators together: the registered queries and their SQL, and the tool surface."""
