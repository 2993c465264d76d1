"""Relational operators over long feature relations."""
