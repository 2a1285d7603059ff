"""Checks that need one row only, so they hold on streams as on tables."""
