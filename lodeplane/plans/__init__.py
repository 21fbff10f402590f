"""Plans: storage between iterations, the layout, and the registered queries."""
