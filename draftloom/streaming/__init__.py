"""draftloom.streaming"""
