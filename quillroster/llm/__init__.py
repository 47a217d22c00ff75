"""Training-data operators over a documents table (text in, decisions and digests out).

Nothing outside this subpackage imports it.
"""
