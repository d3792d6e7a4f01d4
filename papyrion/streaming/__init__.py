"""papyrion.streaming"""
