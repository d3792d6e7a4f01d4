"""papyrion.sources"""
