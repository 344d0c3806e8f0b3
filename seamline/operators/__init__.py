"""DataFrame operators over ordered documents, label sets and runs."""
