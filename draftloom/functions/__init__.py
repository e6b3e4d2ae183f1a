"""draftloom.functions"""
