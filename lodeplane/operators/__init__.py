"""Operators over nodes, edges and points, as DataFrame plans."""
