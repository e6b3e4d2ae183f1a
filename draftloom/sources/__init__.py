"""draftloom.sources"""
