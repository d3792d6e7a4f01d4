"""papyrion.operators"""
