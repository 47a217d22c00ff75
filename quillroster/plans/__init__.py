"""quillroster plans"""
