"""Whole jobs: desired state, change set, copies, documents, baseline, migration."""
