"""Exam-paper catalogue jobs and training-data operators on Spark."""
