"""Readers and writers of tables, and adapters that make page tables of other ones."""
