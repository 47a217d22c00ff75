"""quillroster operators"""
