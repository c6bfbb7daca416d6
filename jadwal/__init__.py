"""Timetable analytics on Spark."""
