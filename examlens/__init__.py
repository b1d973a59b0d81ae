"""Exam-enrolment analytics as Spark DataFrame operators."""
