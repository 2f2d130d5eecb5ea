"""Registered queries: each operator run over whole tables, with its SQL twin.

A module defines queries with the ``query`` decorator of ``catalog.core``.
"""
