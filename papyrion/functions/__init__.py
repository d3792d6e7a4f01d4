"""papyrion.functions"""
