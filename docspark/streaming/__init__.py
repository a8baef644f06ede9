"""docspark.streaming"""
