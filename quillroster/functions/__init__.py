"""quillroster functions"""
