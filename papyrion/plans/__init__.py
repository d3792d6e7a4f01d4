"""papyrion.plans"""
