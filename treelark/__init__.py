"""Source-tree analytics as lazy DataFrame functions."""
