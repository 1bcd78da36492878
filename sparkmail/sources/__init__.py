"""Readers: mbox archives, landed message documents, summary documents."""
