"""Where files, symbols, edges and logs come from, and where results go."""
