"""docspark.plans"""
