"""quillroster : registration analytics as Spark DataFrame functions"""
