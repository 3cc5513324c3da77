"""Registered queries: every operator over the driver tables, with its SQL counterpart."""
