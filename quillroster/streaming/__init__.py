"""quillroster streaming"""
