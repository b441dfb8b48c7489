"""Readers of landed feeds, pages, daily files and logs; writers of tables and reports."""
