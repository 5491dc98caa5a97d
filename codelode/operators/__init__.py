"""Relational, graph, trace and parsing operators over the engine tables."""
