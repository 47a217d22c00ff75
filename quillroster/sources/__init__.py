"""quillroster sources"""
